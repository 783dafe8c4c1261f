"""Column functions (scalar expressions, evaluated inside whole-stage codegen)."""
