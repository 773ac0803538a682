from lexiframe.functions import hashing, text, vectors

__all__ = ["hashing", "text", "vectors"]
