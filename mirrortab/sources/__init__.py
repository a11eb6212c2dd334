"""Reading tables, the split layout, versioned run tables and the dataset registry."""
