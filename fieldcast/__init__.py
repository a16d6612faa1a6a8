"""fieldcast: hyperlocal farm-weather analytics as Spark DataFrame transformations."""
