"""textlake: DataFrame operators that structure, search and maintain large text collections."""
