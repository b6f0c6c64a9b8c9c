"""docuplane.streaming."""
