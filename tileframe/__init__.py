"""tileframe: filter-and-aggregate analytics and time-series operators on Spark."""

__version__ = "0.1.0"
