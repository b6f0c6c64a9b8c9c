"""docuplane.functions."""
