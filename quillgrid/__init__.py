"""quillgrid: a PySpark-native engine for classifying, evaluating and analysing text records."""
