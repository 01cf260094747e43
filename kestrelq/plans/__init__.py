"""Plans: trees, the strict dialect, explanations, estimates and profiles."""
