"""Reading and writing cohort folders."""
