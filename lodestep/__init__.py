"""A PySpark engine for traces of multi-step agent requests and off-line policy evaluation."""
