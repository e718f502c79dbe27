"""Plans made of operators of the engine."""
