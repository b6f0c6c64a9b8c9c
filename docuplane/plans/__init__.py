"""docuplane.plans."""
