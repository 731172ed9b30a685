"""A Spark-native analytics engine for provenance graphs: collections of texts and the chains that passed them on."""
