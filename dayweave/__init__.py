"""dayweave: work-activity analytics over observation tables, written for Spark."""
