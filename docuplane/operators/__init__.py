"""docuplane.operators."""
