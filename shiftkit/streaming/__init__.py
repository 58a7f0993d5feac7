"""Results that arrive while an experiment runs."""
