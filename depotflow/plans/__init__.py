"""The products: star schema, forecasts, customer scores, warehouse operations, marts and their checks."""
