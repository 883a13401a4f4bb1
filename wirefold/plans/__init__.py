"""End-to-end plans and the stand-in tables used by the checks."""
