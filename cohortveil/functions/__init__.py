"""Part of the cohort de-identification library."""
