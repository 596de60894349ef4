"""quillstone: an evidence-memory analytics engine on PySpark."""
