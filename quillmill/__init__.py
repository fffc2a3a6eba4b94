"""quillmill: a Spark-first engine for preparing and analysing text corpora."""
