"""DataFrame-to-DataFrame operators: resolution, diff, rollups, events, scenarios, reports."""
