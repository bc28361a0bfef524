"""mealops: meal-ordering analytics as Spark DataFrame jobs.

Every operator is a pure function ``(frames..., *, params) -> DataFrame``
built from Spark SQL built-ins; time ("now") is always a parameter.
"""

__version__ = "0.1.0"
