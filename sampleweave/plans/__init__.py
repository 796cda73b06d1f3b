"""Plans: the graph layer and the registry of whole queries."""
