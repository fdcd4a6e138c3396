"""DataFrame -> DataFrame operators (aggregation specs, encoding,
joins, profiling, ranking, sampling, preparation, metrics, SMOTE,
model training)."""
