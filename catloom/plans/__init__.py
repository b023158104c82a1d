"""Named queries; importing the modules registers them."""
