"""docengine: document-evidence review and text-corpus analytics as PySpark DataFrame plans."""
