"""Detection, diff, suppression, scoring and review operators."""
