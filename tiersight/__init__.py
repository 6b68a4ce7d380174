"""Analytics over hierarchical, multi-period statistical data, written as Spark DataFrame jobs."""
