"""Column expressions and plain helpers: guards, dates, sample sizes."""
