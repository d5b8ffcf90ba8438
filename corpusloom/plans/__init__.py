"""Plans of corpusloom."""
