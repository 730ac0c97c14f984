"""Reading tables, deriving the logical inputs, writing results."""
