"""gristmill: dataset curation, evaluation and cost analytics as Spark plans."""
