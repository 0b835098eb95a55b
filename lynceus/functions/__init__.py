"""Column functions: no action, no shuffle, whole-stage codegen where Spark allows."""
