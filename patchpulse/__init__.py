"""Update-impact analytics as Spark DataFrame operators."""
