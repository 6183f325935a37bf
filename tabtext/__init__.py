"""tabtext: supervised learning on tables and text as Spark jobs.

Sub-packages: ``sources`` (tables, CSV pair, sinks), ``functions`` (column
functions), ``operators`` (checks, features, evaluation, attributions,
models), ``plans`` (fixtures, registered queries, oracle SQL, jobs),
``streaming`` (scoring of streams with fitted models).
"""

__version__ = "0.1.0"
