"""Where indexes and documents come from and go to."""
