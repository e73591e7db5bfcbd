"""Evidence-anchored claim analytics on PySpark."""
