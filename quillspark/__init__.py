"""quillspark: text and discourse analytics as Spark DataFrame plans."""
