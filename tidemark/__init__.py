"""Version-control history analytics as composable DataFrame operators."""
