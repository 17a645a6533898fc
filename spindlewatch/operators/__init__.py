"""DataFrame -> DataFrame building blocks: cleaning, failure counts, disk collapse, ranking."""
