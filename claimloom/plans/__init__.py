"""The engine's run and the registered queries."""
