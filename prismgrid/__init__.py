"""prismgrid: photogrammetry-style analytics as composable Spark DataFrame operators."""
