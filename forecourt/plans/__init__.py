"""The order-and-lineitem test data seen as a dealership, and the registered queries over it."""
