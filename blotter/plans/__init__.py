"""Query registry, session setup, plan checks and the SQL oracle."""
