"""Tables from memory and files, and back."""
