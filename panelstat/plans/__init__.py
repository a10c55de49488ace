"""End-to-end flows: raw export to structured panels, cohort profiles, pair-effect analysis."""
