"""Graph analytics as DataFrame programs."""
