"""tesselq: an analytics engine on PySpark's DataFrame API."""
