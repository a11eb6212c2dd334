"""Fitted transforms over streams."""
