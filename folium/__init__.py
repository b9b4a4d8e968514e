"""folium: a document-to-relational analytics engine expressed as Spark DataFrame stages."""
