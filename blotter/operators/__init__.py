"""Cohorts, rollups, suspect logic, KPI layers and proof extracts."""
