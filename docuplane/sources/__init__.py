"""docuplane.sources."""
