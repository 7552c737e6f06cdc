"""quillspark: document conformance and corpus analytics as Spark jobs."""
