"""DataFrame to DataFrame steps.  Nothing here collects rows to the driver."""
