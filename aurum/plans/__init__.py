"""Expression trees and the request registry."""
