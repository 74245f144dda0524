"""fieldmark: a data-usability analytics engine built on the Spark DataFrame API."""
