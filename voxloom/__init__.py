"""voxloom: transcript and corpus analytics on PySpark."""
