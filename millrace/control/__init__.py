"""Driver-side services round the plans: lineage, versions, schedules, monitoring, security, deployment."""
