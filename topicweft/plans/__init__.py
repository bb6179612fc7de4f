"""Loop, skew and session helpers, and the bindings of operators to tables."""
