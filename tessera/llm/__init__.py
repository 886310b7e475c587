"""Training-data operators at corpus scale; each module is one operator."""
