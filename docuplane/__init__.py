"""docuplane: document search and corpus processing as PySpark plans."""
