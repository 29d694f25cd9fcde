"""clipsieve: a PySpark-native engine for the data side of counterfactual video editing."""
