"""Operations of a training-data pipeline: thirteen operators, their queries and SQL.

Nothing else in the library imports this subpackage."""
