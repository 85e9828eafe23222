"""Learning-analytics jobs on Apache Spark: notebook roll-ups, report extraction, admission and keyed state."""
