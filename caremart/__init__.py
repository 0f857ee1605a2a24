"""caremart: care-outcome analytics as lazy Spark DataFrame operators.

The package builds one cleaned, imputed and direction-normalised outcome mart
from session, cost and reference tables and offers column-parameterised
``DataFrame -> DataFrame`` operators on top of it.  Everything is expressed with
the DataFrame / SQL API so Catalyst and AQE choose the physical plan.
"""

from caremart.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
