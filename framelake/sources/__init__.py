"""Tables and the frame-shaped views over them."""
