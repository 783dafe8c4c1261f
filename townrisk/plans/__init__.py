"""Plans: the engine's analyses built from sources and operators."""
