"""Reading and writing vector sets."""
