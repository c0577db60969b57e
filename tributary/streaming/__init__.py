"""The reference has no unbounded operator: no windows over streams, watermarks or state. Batch operators that work
row by row (sources, projections, filters) accept streaming DataFrames as they are; nothing else is offered here."""
