"""Operations that a training-data pipeline needs, as Spark jobs. Nothing else in the library imports this subpackage."""
