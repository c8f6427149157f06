"""Query specifications, the aggregation language and raster plans."""
