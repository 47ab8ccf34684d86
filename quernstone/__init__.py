"""quernstone: multilingual ranked document retrieval as PySpark DataFrame plans."""
