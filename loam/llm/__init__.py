"""Training-data operators: each module holds one operator, its parameters and its defined edge cases."""
