"""Job configuration and the table of formats."""
