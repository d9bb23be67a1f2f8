"""driftlens: API-surface diffs, migration rules and corpus operators on Spark."""
