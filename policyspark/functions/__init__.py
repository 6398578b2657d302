"""policyspark subpackage."""
