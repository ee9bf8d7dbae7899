"""Distributions and small dense algebra on the driver."""
