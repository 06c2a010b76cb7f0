"""Control plans: capacities, method options and whole runs."""
