"""Semantic-record processing on PySpark: text rules, message logs and ontology graphs."""
