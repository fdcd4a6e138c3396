"""Sources and sinks: CSV scan / sink with null tokens, model,
preprocessing and metric stores."""
