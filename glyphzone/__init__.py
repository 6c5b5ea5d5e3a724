"""glyphzone: a PySpark-native engine for machine readable zones and the records derived from them."""
